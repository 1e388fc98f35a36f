"""Column functions: classification of published fields, dates and display."""
