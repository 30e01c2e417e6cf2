"""Arrays that several test modules use."""

import numpy as np


def ramp(width: int, height: int) -> np.ndarray:
    """x + 2y over the unit square."""
    x, y = np.meshgrid(np.linspace(0, 1, width, dtype=np.float32), np.linspace(0, 1, height, dtype=np.float32))
    return x + 2.0 * y
