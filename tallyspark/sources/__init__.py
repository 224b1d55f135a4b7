"""tallyspark.sources"""
