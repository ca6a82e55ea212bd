"""Column functions: text features, markers, validation rules, formats."""
