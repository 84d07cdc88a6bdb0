"""loamwork.sources"""
