"""tallyforge.sources"""
