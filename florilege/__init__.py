"""Florilege: DataFrame operators for web-collected text and the knowledge drawn from it."""
