"""The operators: functions over DataFrames that return DataFrames."""
