"""casefile.sinks"""
