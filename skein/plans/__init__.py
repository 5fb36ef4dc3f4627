"""skein.plans"""
