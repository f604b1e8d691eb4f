"""casefile.functions"""
