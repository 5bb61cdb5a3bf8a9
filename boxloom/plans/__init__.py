"""boxloom.plans"""
