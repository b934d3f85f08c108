"""contractlog.functions"""
