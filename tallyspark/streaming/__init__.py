"""tallyspark.streaming"""
