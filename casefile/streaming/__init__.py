"""casefile.streaming"""
