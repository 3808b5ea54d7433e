"""Spark-native analytics over RGB-D capture sequences: frames, pixels, points, poses, voxels and quality metrics."""
