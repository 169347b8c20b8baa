"""annolytics.functions"""
