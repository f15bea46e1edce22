"""tallyforge.operators"""
