"""attestia.functions"""
