"""Multi-device, local-first data resolved, served and synchronised with DataFrames."""
