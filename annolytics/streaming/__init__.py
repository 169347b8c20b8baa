"""annolytics.streaming"""
