"""attestia.streaming"""
