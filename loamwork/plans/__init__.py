"""loamwork.plans"""
