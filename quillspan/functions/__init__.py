"""Column functions: text, dates, numbers and keys. All are built-ins but for the Unicode normalisation."""
