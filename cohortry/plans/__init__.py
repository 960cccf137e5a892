"""Feature plans and the end-to-end segmentation jobs."""
