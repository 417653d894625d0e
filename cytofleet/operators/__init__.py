"""Operators: rules, raster algebra, cell features, population statistics, screens, graphs, priors."""
