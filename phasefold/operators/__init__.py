"""The analytic operators: embedding, projection, cross mapping, ensembles, surrogates."""
