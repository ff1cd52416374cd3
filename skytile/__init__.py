"""skytile: Spark jobs for aerial-image annotation, tiling, detection and evaluation."""
