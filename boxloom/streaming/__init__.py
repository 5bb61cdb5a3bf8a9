"""boxloom.streaming"""
