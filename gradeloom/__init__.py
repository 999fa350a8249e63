"""PySpark jobs for analysing marked assessments, from page images to per-student feedback."""
