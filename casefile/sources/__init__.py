"""casefile.sources"""
