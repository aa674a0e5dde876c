"""Column functions. All are JVM-side except the Arrow helpers in ``arrow``."""
