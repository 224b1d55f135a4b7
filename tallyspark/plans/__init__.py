"""tallyspark.plans"""
