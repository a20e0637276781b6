"""partyframe.functions"""
