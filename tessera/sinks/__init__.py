"""Reports, label files and backups as results of Spark jobs."""
