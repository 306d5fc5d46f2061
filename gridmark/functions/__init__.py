"""Column functions: text, grids of cells, metrics, names and layouts."""
