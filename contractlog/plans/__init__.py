"""contractlog.plans"""
