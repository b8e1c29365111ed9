"""permspark.streaming"""
