"""Column functions on spectra, histograms and sets."""
