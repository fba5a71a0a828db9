"""Column functions: kinematics, weights, interpretation text and p-values."""
