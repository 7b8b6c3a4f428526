"""Sequential numerics in numpy, run as grouped maps."""
