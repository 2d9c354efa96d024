"""Column functions: text, dates, geodesy, shapes and cells."""
