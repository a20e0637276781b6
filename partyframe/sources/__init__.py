"""partyframe.sources"""
