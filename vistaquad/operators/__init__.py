"""DataFrame operators of calibration, rasters, stitching and reports."""
