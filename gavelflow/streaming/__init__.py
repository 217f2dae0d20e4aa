"""The bid stream: change points, extensions, close timers, repricing."""
