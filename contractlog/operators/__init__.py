"""contractlog.operators"""
