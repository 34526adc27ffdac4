"""Multi-session LiDAR map merging and cleaning, expressed as Spark jobs."""
