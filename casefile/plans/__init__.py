"""casefile.plans"""
