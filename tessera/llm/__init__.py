"""Operators for training-data problems on texts and similarity; nothing else in the package imports this one."""
