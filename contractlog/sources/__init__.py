"""contractlog.sources"""
