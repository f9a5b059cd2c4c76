"""skein.sources"""
