import numpy as np

from lexspark.llm.logbilinear import CONTEXT, RATE, UNITS, Model


def test_one_step_equals_plain_loops():
    draw = np.random.default_rng(3)
    p_noise = draw.random(UNITS) + 0.1
    p_noise /= p_noise.sum()
    context, target, noise = draw.integers(0, UNITS + 1, (CONTEXT, 40)), draw.integers(0, UNITS, 40), draw.integers(0, UNITS, 7)
    before = Model.start(p_noise)
    vectors, weights, outputs, bias = [p.astype(float) for p in before.parts]
    grads = [np.zeros_like(p) for p in (vectors, weights, outputs, bias)]
    shift = np.log(len(noise) * p_noise)
    for b in range(len(target)):
        predicted = sum(weights[i] * vectors[context[i, b]] for i in range(CONTEXT))
        pull = np.zeros_like(predicted)
        for unit, right in [(target[b], True), *[(u, False) for u in noise]]:
            score = predicted @ outputs[unit] + bias[unit] - shift[unit]
            d = 1 / (1 + np.exp(score)) if right else -1 / (1 + np.exp(-score))
            grads[2][unit] += d * predicted
            grads[3][unit] += d
            pull += d * outputs[unit]
        for i in range(CONTEXT):
            grads[0][context[i, b]] += pull * weights[i]
            grads[1][i] += pull * vectors[context[i, b]]
    model, squares = Model(before.flat.copy()), [np.zeros_like(p) for p in before.parts]
    model.step(context, target, noise, p_noise, squares)
    for part, old, g in zip(model.parts, before.parts, grads, strict=True):
        g = g / len(target)
        assert np.allclose(part, old + RATE * g / np.sqrt(g * g + 1e-8), atol=1e-3)


def test_unit_probabilities_add_up_to_one_and_equal_a_softmax():
    draw = np.random.default_rng(4)
    model = Model(draw.normal(0, 0.5, len(Model.start(np.full(UNITS, 1 / UNITS)).flat)).astype(np.float32))
    vectors, weights, outputs, bias = [p.astype(float) for p in model.parts]
    context = draw.integers(0, UNITS + 1, (CONTEXT, 1))
    got = model.log10_units(np.repeat(context, UNITS, 1), np.arange(UNITS))
    scores = sum(weights[i] * vectors[context[i, 0]] for i in range(CONTEXT)) @ outputs.T + bias
    assert np.allclose(10**got, np.exp(scores) / np.exp(scores).sum(), atol=1e-6) and abs((10**got).sum() - 1) < 1e-5
