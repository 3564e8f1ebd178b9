"""careerline: competition results analysed by age instead of by season, on Spark.

``functions``  column expressions (typing, ages, rounding)
``operators``  DataFrame -> DataFrame building blocks, nothing sport-specific
``sources``    file discovery, text load with a hash manifest, versioned tables
``plans``      the layered models, their checks, the reports and the full run
"""
