"""Operators: the lazy query type with its projections, joins, groups, sorting, paging, zips and unions."""
