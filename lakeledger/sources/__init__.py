"""Reading and writing tables, and views that give the driver's tables the shape of observation data."""
