"""lagwise: time-series similarity, spectra and clustering as DataFrame-to-DataFrame operators."""
