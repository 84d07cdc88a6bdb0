"""loamwork.functions"""
