"""attestia.sources"""
