"""partyframe.operators"""
