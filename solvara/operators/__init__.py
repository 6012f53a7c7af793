"""Table operators, grouped as in the survey inventory."""
