"""permspark.sources"""
