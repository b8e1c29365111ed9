"""permspark.plans"""
