"""Several reports over one scan, and the views that the driver's contract runs on."""
