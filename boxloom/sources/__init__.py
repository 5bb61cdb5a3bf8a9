"""boxloom.sources"""
