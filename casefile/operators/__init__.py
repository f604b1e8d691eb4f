"""casefile.operators"""
