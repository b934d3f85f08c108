"""contractlog.streaming"""
