"""permspark.operators"""
