"""boxloom.operators"""
