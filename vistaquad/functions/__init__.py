"""Column functions of points, homographies and quads."""
