"""Track-clearance analytics on PySpark: lidar frames in, fail-closed decisions and quality reports out."""
