"""attestia.plans"""
