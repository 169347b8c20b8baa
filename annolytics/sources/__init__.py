"""annolytics.sources"""
