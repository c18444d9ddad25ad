"""firnline.plans"""
