"""attestia.operators"""
