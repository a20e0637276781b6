"""partyframe.streaming"""
