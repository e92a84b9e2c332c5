"""Schemas of the tables."""

POINTS = "camera_id string, idx int, src_x double, src_y double, dst_x double, dst_y double"
ROLES = "camera_id string, role string, pos int, idx int"
QUAD = "array<struct<x:double,y:double>>"
SQUARES = f"image_id string, square_id int, corners {QUAD}"
HOMOGRAPHY = "struct<h00:double,h01:double,h02:double,h10:double,h11:double,h12:double,h20:double,h21:double,h22:double>"
#: Packed images: rows of interleaved bytes, blue first where there are three channels.
IMAGES = "image_id string, height int, width int, channels int, data binary"
STAGES = "array<struct<method:string,bounds:string,weight:double>>"
TRIALS = f"camera_id string, trial_id int, levels int, stages {STAGES}"
RESULTS = f"camera_id string, trial_id int, stages {STAGES}, success boolean, error string, initial_error double, optimized_error double, improvement double, improvement_percent double, squares_count int, homography {HOMOGRAPHY}"
