"""pixweft: image containers, codes, transforms and pixels as Spark relations."""
