"""annolytics.plans"""
