"""boxloom.functions"""
