"""loamwork.streaming"""
