"""firnline.streaming"""
