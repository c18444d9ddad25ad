"""firnline: points, tracks, tiles and rasters as Spark DataFrames.

Every operator takes and returns a ``DataFrame``; nothing here holds rows on
the driver.  See README.md for the map of modules.
"""

__version__ = "0.1.0"
