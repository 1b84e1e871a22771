"""Parameter grids, sweeps and many-column fan-outs."""
