"""permspark.functions"""
