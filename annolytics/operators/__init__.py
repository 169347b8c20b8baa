"""annolytics.operators"""
